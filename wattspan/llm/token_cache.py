"""Whole texts to token ids with the tokenizers library, by way of distinct words.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct word is encoded once by
the library's model, and the ids of the words are joined. Bounded memos keep words between batches; they
hold no result that the library would not give again, so clearing them changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from wattspan.llm.workers import hold

#: A memo has two generations of about so many bytes in each Python process.
MEMO_BYTES = 80_000_000
#: For words of texts cut at white space, of which more differ, as punctuation stays on them.
MEMO_WHITE_SPACE_BYTES = 120_000_000
#: What an entry takes beside the characters of its word and the bytes of its ids.
ENTRY_BYTES = 190
#: Longer words are not kept.
LONGEST_WORD = 200
#: Texts are taken together up to so many characters.
CHUNK_CHARS = 1_000_000

_SPACE_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The split pattern of byte-level tokenizers, and the same for texts of ASCII and Latin-1 letters only.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NOT_LATIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")


def white_space_words(text: str) -> list[str]:
    """Runs without Unicode White_Space. ``str.split`` would also cut at four control characters."""
    if any(c in text for c in _SPACE_CONTROLS):
        import regex

        return regex.findall(r"[^\t-\r \x85\p{Z}]+", text)
    return text.split()


def pattern_words(pattern: str) -> Callable[[str], list[str]]:
    import regex

    general = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return general
    latin, other = _LATIN.findall, _NOT_LATIN.search
    return lambda text: general(text) if other(text) else latin(text)


def has_unassigned(text: str) -> bool:
    """Whether a text has characters that this Python's Unicode does not know. Engines of other versions may
    know them, and then split at other places."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Values of a function by two generations: when the young one is full, it becomes the old one."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > LONGEST_WORD:
                return found
        self[word] = found
        self.size += ENTRY_BYTES + len(word) + len(found)
        return found

    def age(self) -> None:
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    With a ``pattern``, the tokenizer must be a byte-level one that splits by it; without, one that cuts at
    white space at least. Its own normaliser, split pattern and model are used on words; of a tokenizer
    whose file says something else, the whole pipeline is run on each word; likewise on whole texts with
    unassigned characters.
    """

    def __init__(self, tokenizer_path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # As the description of the tokenizer files has it: the strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.split = pattern_words(pattern) if pattern else white_space_words
        self._table = byte_characters()
        self._blank = self._table[32]
        self._tokenize = self.tokenizer.model.tokenize
        with open(tokenizer_path, encoding="utf-8") as f:
            config = json.load(f)
        steps, norm = config["pre_tokenizer"], config["normalizer"]
        parts = steps.get("pretokenizers", [steps]) if steps else []
        kinds = [p["type"] for p in parts]
        make = self._whole
        if pattern and kinds == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"] and not norm:
            make = self._piece
        elif not pattern and kinds == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            import regex

            self._cut = regex.compile(parts[0]["pattern"]["Regex"]).findall
            # Runs of letters are one piece, and nothing before that alternative begins with a letter.
            self._whole_letters = parts[0]["pattern"]["Regex"] == LETTER_RUNS
            plain = {"NFC", "Replace", "Lowercase"}
            self._ascii_lower = bool(norm) and {n["type"] for n in norm.get("normalizers", [norm])} == plain
            self.pieces = Memo(self._piece, MEMO_BYTES)
            make = self._word
        self.memo = Memo(make, MEMO_BYTES if pattern else MEMO_WHITE_SPACE_BYTES)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isascii() and bare.isprintable() and " " not in bare:  # those bytes stand for themselves
            coded = self._blank + bare if len(bare) < len(piece) else piece
        else:
            coded = piece.encode("utf-8").decode("latin-1").translate(self._table)
        return array("I", [t.id for t in self._tokenize(coded)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self._ascii_lower and word.isascii():
            plain = word.lower()
            if self._whole_letters and plain.isalpha():
                return self.pieces[plain]
        else:
            plain = self.tokenizer.normalizer.normalize_str(word)
        return b"".join(map(self.pieces.__getitem__, self._cut(plain)))

    def encode(self, texts: list[str]) -> list[bytes]:
        get, split = self.memo.__getitem__, self.split
        out = [self._whole(t) if not t.isascii() and _NOT_LATIN.search(t) and has_unassigned(t) else b"".join(map(get, split(t))) for t in texts]
        self.memo.age()
        if hasattr(self, "pieces"):
            self.pieces.age()
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(tokenizer_path: str, pattern: str | None) -> WordEncoder:
    """The process's encoder for a vocabulary; ``pattern`` None cuts at white space."""
    key = (tokenizer_path, pattern)
    hold(f"encoder {key}", lambda: _ENCODERS.pop(key, None))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_path, pattern)
    return _ENCODERS[key]


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts together up to ``CHUNK_CHARS``; null becomes empty."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_column(enc: WordEncoder, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Position of the first text, and ids, of one chunk after another of an Arrow string column."""
    at = 0
    for part in chunks(x.as_py() for x in column):
        yield at, enc.encode(part)
        at += len(part)
