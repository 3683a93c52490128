"""Token ids of whole texts by the tokenizers library, with a bounded memo of the parts of a text that repeat.

A text is cut where the tokenizer itself never joins two parts (at blanks), each different part is encoded by the
library once, and the ids of a text are those of its parts in order. `tests/llm` holds this against encoding whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pre-tokens of the two kinds of tokenizer that cut points are known for; used on Latin text only.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of Latin letters only, which every Unicode version classes alike.
LATIN = regex.compile(r"[\n\x20-\x7e¡-¬®-ɏ]+")
LAST_LATIN = "ɏ"
#: Packs of few ids, by their number.
PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]
#: Line ends beside other blanks, which may be one token with them.
LOOSE_LINE = regex.compile(r"\s\n|\n\s|\n\Z")
#: Begins a text's first part in `encode_many`; texts that hold it take the longer way.
START = "\0"
#: The letter whose lower case ends in a sign that isn't one, and that a mark after it would join.
DOTTED = "İ"
#: Begins a mark that followed a letter there, so that words are looked up without their marks.
GLUED = "\x01"
#: A letter and a mark after it, which no tokenizer of either kind joins.
AFTER = r"(\p{L})([.,;:!?])"
MARKS = frozenset(".,;:!?")
#: Parts of the texts whose ids are put together at once.
RUN_WORDS = 300_000
#: Entries of a generation of a memo of parts, and of one of pre-tokens; two generations are kept.
PARTS, TOKENS = 400_000, 150_000
#: Bits of a string's hash by which a memo knows that it came before.
DOOR = 22


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A function of strings with its last results, of strings that came twice: half of a text's different words come once."""

    def __init__(self, f, most: int) -> None:
        super().__init__()
        self.f, self.most, self.old, self.door = f, most, {}, bytearray(1 << DOOR)

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found, at = self.f(part), hash(part) & (1 << DOOR) - 1
            if not self.door[at]:
                self.door[at] = 1
                return found
        if len(self) >= self.most:
            self.old, self.door = dict(self), bytearray(1 << DOOR)
            self.clear()
        self[part] = found
        return found


class Encoder:
    """Encodes texts to the bytes of their ids (little-endian unsigned 32-bit), without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = self.full.model.tokenize
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre, norm = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif pre.get("type") == "Sequence" and norm and "Lowercase" in str(norm) and "'behavior': 'Removed'" in str(pre) and rules["model"].get("end_of_word_suffix"):
            self.kind = "word"
        self.letters = _byte_letters()
        self.token = Memo(self._token, TOKENS)
        self.part = Memo(self._word_part if self.kind == "word" else self._byte_part, PARTS)
        self.first = Memo(self._first, TOKENS)
        self.unit = self.part if self.kind == "word" else Memo(self._unit, PARTS)

    def _whole(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := self.full.encode(text, add_special_tokens=False).ids) else b""

    def _token(self, token: str) -> bytes:
        """Of one pre-token."""
        shown = token if token.isascii() and token.isprintable() and token[0] != " " else token.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.bare(shown)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _word_part(self, part: str) -> bytes:
        if not part:
            return b""
        low = part.lower()
        if low.isalpha() and max(part) <= LAST_LATIN:
            return self._token(low) if low == part else self.part[low]
        if not LATIN.fullmatch(part):
            return self._whole(part)
        if low[-1] in MARKS and low[:-1].isalpha():
            return self.part[low[:-1]] + self.token[part[-1]]
        return b"".join([self.token[x] for x in WORD_PATTERN.findall(low)])

    def _first(self, part: str) -> bytes:
        """Of a part with nothing or a line end before it."""
        if not part:
            return b""
        if not LATIN.fullmatch(part):
            return self._whole(part)
        return b"".join([self.token[x] for x in BYTE_PATTERN.findall(part)])

    def _byte_part(self, part: str) -> bytes:
        """Of a part and the blank before it."""
        if part.isalpha():
            return self._token(" " + part)
        if part and part[-1] in MARKS and part[:-1].isalpha():
            return self.part[part[:-1]] + self.token[part[-1]]
        if not LATIN.fullmatch(part):
            return self._whole(" " + part)
        return b"".join([self.token[x] for x in BYTE_PATTERN.findall(" " + part)])

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.first[first] + b"".join(map(self.part.__getitem__, rest))

    def _unit(self, unit: str) -> bytes:
        """Of what stands between blanks where START begins a text, a blank stands before each line end, and one and GLUED
        before a mark that follows a letter."""
        if unit[:1] == START or unit[:1] == GLUED:
            return self.first[unit[1:]]
        return self.token["\n"] + self.first[unit[1:]] if unit[:1] == "\n" else self._byte_part(unit)

    def _regular(self, text: str) -> bool:
        """Whether `encode` cuts the text at blanks and line ends alone."""
        if self.kind == "whole" or any(s in text for s in self.special):
            return False
        if self.kind == "word":
            return DOTTED not in text
        return not ("  " in text or START in text or GLUED in text or LOOSE_LINE.search(text))

    def encode_runs(self, texts: pa.Array, most: int = RUN_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, bounds) of runs of texts, of `most` parts or one text each: their ids, one text after the other,
        and where each one's begin, and the last's end. Nulls are empty.

        The parts of all texts are made a dictionary first, so that each different one is looked up once.
        """
        texts = texts.fill_null("")
        odd = {i: t for i, t in enumerate(texts.to_pylist()) if not self._regular(t)}
        if odd:
            texts = pa.array(["" if i in odd else t for i, t in enumerate(texts.to_pylist())], pa.string())
        if self.kind == "word":  # which lower-cases, and knows no blanks
            plain = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), AFTER, r"\1 \2")
        else:
            plain = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), AFTER, rf"\1 {GLUED}\2")
            plain = pc.binary_join_element_wise(START, plain, "")
        parts = pc.split_pattern(plain, " ")
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy()))).astype(np.int64)
        known = parts.flatten().dictionary_encode()
        code = known.indices.to_numpy()
        each = list(map(self.unit.__getitem__, known.dictionary.to_pylist()))
        del parts, known, plain
        size = np.fromiter(map(len, each), np.int32, len(each)) // 4
        held = np.frombuffer(b"".join(each), "<u4")
        start = (np.cumsum(size) - size).astype(np.int32)
        edges = [0, *(np.flatnonzero(np.diff(at[1:] // most)) + 1).tolist(), len(texts)]
        for lo, hi in zip(edges, edges[1:]):
            c = code[at[lo] : at[hi]]
            n = size[c]
            end = np.cumsum(n, dtype=np.int32)
            ids = held[np.repeat(start[c] - end + n, n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]
            bounds = np.concatenate(([0], end))[at[lo : hi + 1] - at[lo]].astype(np.int64)
            if any(i in odd for i in range(lo, hi)):
                runs = [np.frombuffer(self.encode(odd[i]), "<u4") if i in odd else ids[bounds[i - lo] : bounds[i - lo + 1]] for i in range(lo, hi)]
                ids, bounds = np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            yield lo, hi, ids, bounds

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode_runs` in one."""
        runs = list(self.encode_runs(texts))
        if not runs:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        shift = np.cumsum([0, *(len(ids) for _, _, ids, _ in runs)])
        return np.concatenate([ids for _, _, ids, _ in runs]), np.concatenate([[0], *(b[1:] + s for (_, _, _, b), s in zip(runs, shift))])

    def encode(self, text: str) -> bytes:
        if self.kind == "whole" or any(s in text for s in self.special):
            return self._whole(text)
        if self.kind == "word":
            return b"".join(map(self.part.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text:  # a run of blanks may be one token
            return self._whole(text)
        if LOOSE_LINE.search(text):
            return self._line(text)
        return self.token["\n"].join(map(self._line, text.split("\n")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer."""
    if path not in _ENCODERS:
        gc.set_threshold(200_000, 20, 100)  # memos of strings have no cycles; looking for some takes a tenth of the time
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
