"""Token ids of whole texts by the tokenizers library, with a bounded cache of the ids of text chunks.

A text is cut where no token can reach across: between a word and the white space after it. The library encodes each
new chunk; repeated chunks come from the cache, so the ids are the library's own. Where the tokenizer lowers letters, chunks are
lowered first, and where it keeps letters and the punctuation behind them apart, each is encoded once by itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: White space beyond the ASCII one: texts with it go to the library whole, since a token may reach across a cut there.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_SPACED = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_PLAIN = re.compile(r" ?[^\x20\x09-\x0D]+")
#: Letters, then punctuation without apostrophes, which some tokenizers join with letters. Latin-1 letters have no compositions.
_ENDED = re.compile(r"([ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: Splits of letters, digits and other signs from each other.
_APART = ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"]
_JOIN = 200
#: Characters whose chunks are held and looked up together: few enough to stay in a processor's cache.
CALL_CHARS = 120_000


def _rules(tokenizer) -> tuple[bool, bool]:
    """Whether a tokenizer lowers letters, and whether it never joins letters and punctuation behind them; no, where it is not known."""
    spec = json.loads(tokenizer.to_str())
    normalizer, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = [x["type"] for x in normalizer.get("normalizers", [normalizer] if normalizer else [])]
    known = set(steps) <= {"NFC", "Lowercase"} or (set(steps) <= {"NFC", "Replace", "Lowercase"} and all(x.get("pattern") == {"Regex": r"\s+"} and x["content"] == " " for x in normalizer["normalizers"] if x["type"] == "Replace"))
    first = (pre.get("pretokenizers") or [pre])[0]
    apart = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    apart = apart or (first.get("type") == "Split" and first["pattern"].get("Regex") in _APART)
    return known and "Lowercase" in steps, bool(known and apart and spec["model"]["type"] == "BPE")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. One lives in each Python worker.

    With special, added tokens' strings in a text get their own ids, as the library does by default; else they are ordinary text.
    """

    def __init__(self, path: str, cache_entries: int = 1_400_000, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        #: Texts with one of these go to the library whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.spaced = self._ids("a b") != self._ids("ab") and len(self._ids("\n")) > 0  # white space has tokens of its own
        self.split = _SPACED.findall if self.spaced else str.split  # other white space than ASCII's is not in these texts
        self.glue = "\n" if self.spaced else " \x01 "
        (self.mark,) = self._ids("\n" if self.spaced else "\x01")
        self.lowers, self.apart = _rules(self.tokenizer)
        self.cache_entries, self.new, self.old = cache_entries, {}, {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks by one call: the glue between them has an id of its own that ends up in no chunk."""
        groups, out = [chunks[i : i + _JOIN] for i in range(0, len(chunks), _JOIN)], []
        found = self.tokenizer.encode_batch_fast([self.glue.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
            if len(cuts) != len(group) - 1:
                out += self._whole(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *[x + 4 for x in cuts]], [*cuts, len(raw)], strict=True)]
        return out

    def _learn(self, chunks: list[str]) -> None:
        if self.spaced:
            easy = [c for c in chunks if _PLAIN.fullmatch(c)]
        else:
            easy = [c for c in chunks if "\x01" not in c]
        rest = chunks if not easy else [] if len(easy) == len(chunks) else list(set(chunks).difference(easy))
        for part, ids in ((easy, self._joined), (rest, self._whole)):
            for i in range(0, len(part), 20_000):
                self.new.update(zip(part[i : i + 20_000], ids(part[i : i + 20_000]), strict=True))

    def _chunks(self, text: str) -> list[str] | None:
        """The text's chunks; None: the library takes it whole."""
        if _ODD_SPACE.search(text):
            return None
        if self.lowers and (text.isascii() or _latin(text)):  # letters whose lower forms are the same everywhere
            text = text.lower()
        return None if any(a in text for a in self.added) else self.split(text)

    def _find(self, chunks) -> set[str]:
        """Those of the chunks that are not in the cache; what only its older half has goes to the newer one."""
        new, old, unknown = self.new, self.old, set()
        for c in chunks:
            if c not in new:
                if (ids := old.get(c)) is not None:
                    new[c] = ids
                else:
                    unknown.add(c)
        return unknown

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for a, b in slices(texts, CALL_CHARS) for ids in self._encode(texts[a:b])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > self.cache_entries // 2:
            self.old, self.new = self.new, {}
        split, get = [self._chunks(t) for t in texts], self.new.get
        found = [chunks and list(map(get, chunks)) for chunks in split]
        gaps = [ids and [i for i, x in enumerate(ids) if x is None] for ids in found]
        unknown = self._find({chunks[i] for chunks, at in zip(split, gaps, strict=True) if at for i in at})
        ended = {c: m.groups() for c in unknown if (m := _ENDED.fullmatch(c))} if self.apart else {}
        self._learn(list(self._find({x for pair in ended.values() for x in pair}).union(unknown.difference(ended))))
        new = self.new
        for c, (letters, rest) in ended.items():
            new[c] = new[letters] + new[rest]
        for chunks, ids, at in zip(split, found, gaps, strict=True):
            for i in at or ():
                ids[i] = new[chunks[i]]
        out = [b"".join(ids or ()) for ids in found]
        odd = [i for i, chunks in enumerate(split) if chunks is None]
        if odd:
            for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, special] = Encoder(path, special=special)
    return _ENCODERS[path, special]


def slices(texts: list, max_chars: int = 1_000_000):
    """(from, to) of consecutive texts of at most max_chars characters together, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > max_chars:
            yield start, i
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)
