"""Tokenizing whole texts with the ``tokenizers`` library, each distinct piece once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT_IN_WORKER, trim_heap

#: Unicode's spaces beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
TEXT_BYTES = 4 << 20  # text given to ``encode`` at a time (one document at least)
CALL = 5000  # pieces given to the library in one call, which holds far more memory than their text
_loaded: dict[str, PieceTokenizer] = {}
KEPT_IN_WORKER.append(_loaded)

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE, _WIDE = range(8)


def _kinds() -> np.ndarray:
    """The kind of each byte. Other spaces and control characters are ``_OTHER``: no cut beside them."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = _MARK
    for k in range(128):
        if chr(k).isalpha():
            kinds[k] = _LETTER
        elif chr(k).isdigit():
            kinds[k] = _DIGIT
    kinds[ord("'")], kinds[ord(" ")], kinds[ord("\n")], kinds[128:] = _QUOTE, _SPACE, _LINE, _WIDE
    return kinds


_KIND = _kinds()


def cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 bytes may be cut: before these places a byte-level pre-tokenizer always starts a token.

    That is before a single space between two characters that are no spaces,
    before and after a single line feed between such characters, and where
    ASCII letters or digits meet ASCII marks other than the apostrophe (which
    opens contractions). Beside other spaces there is no cut.
    """
    kind = _KIND[data]
    solid = (kind >= _LETTER) & (kind <= _QUOTE)
    if len(data) and data.max() > 127 and not _WIDE_SPACE.search(data):
        solid |= kind == _WIDE
    out = np.zeros(len(data), bool)
    between = np.zeros(len(data), bool)
    between[1:-1] = solid[:-2] & solid[2:]
    line = between & (kind == _LINE)
    out |= between & (kind == _SPACE)
    out |= line
    out[1:] |= line[:-1]
    word, mark = (kind == _LETTER) | (kind == _DIGIT), kind == _MARK
    out[1:] |= (word[:-1] & mark[1:]) | (mark[:-1] & word[1:])
    return out


def _byte_level() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte; a tab stays."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}, 9: "\t"}


_BYTE_LEVEL = _byte_level()
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")  # letters in every version of Unicode


def _words_and_rest(pieces: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Those that are Latin letters or ASCII digits alone after a space, those that are that without one, and the rest."""
    spaced, words, rest = [], [], []
    for p in pieces:
        after = p[:1] == b" "
        own = p[1:] if after else p
        one = own.isalpha() or own.isdigit() or not own.isascii() and len(own) < 1 << 10 and _LATIN.fullmatch(own.decode("utf-8", "surrogatepass"))
        (rest if not one else spaced if after else words).append(p)
    return spaced, words, rest


def _joined(words: list[bytes]) -> str:
    raw = b"\t".join(words)
    return raw.decode().replace(" ", "\u0120") if raw.isascii() else raw.decode("latin-1").translate(_BYTE_LEVEL)


def _parts(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw, at = ids.tobytes(), (np.flatnonzero(starts) * 4).tolist()
    return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]


class PieceTokenizer:
    """``encode`` of a byte-level BPE file, with the ids of recent pieces kept.

    A text is cut where a token surely starts (see ``cuts``), so the ids of its
    pieces, joined, are the ids of the text. Pieces seen lately come from two
    bounded dictionaries (when the newer is full it becomes the older one); the
    rest go to the library, many at a time. Texts that hold a special token's
    string are encoded in one go.
    """

    def __init__(self, path: str, keep: int = 150_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The same model for words, each of which is one pre-token in byte-level letters, between tabs.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\t")
        vocab = self.library.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True  # a byte-level space
        self.keep, self.longest = keep, longest
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def forget_pieces(self) -> None:
        self.new, self.old = {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
            trim_heap()
        found = [*map(self.new.get, pieces)]
        missing = [k for k, ids in enumerate(found) if ids is None]
        fresh: dict[bytes, bytes] = {}
        if self.old and missing:
            asked = [pieces[k] for k in missing]
            fresh = {p: ids for p, ids in zip(asked, map(self.old.get, asked)) if ids is not None}
        for some, ids_of in zip(_words_and_rest([pieces[k] for k in missing if pieces[k] not in fresh]), (self._encode_spaced, self._encode_words, self._encode_rest)):
            for k in range(0, len(some), CALL):
                own = some[k : k + CALL]
                fresh.update(zip(own, ids_of(own), strict=True))
        for k in missing:
            found[k] = fresh[pieces[k]]
        self.new.update(fresh)
        for p in fresh:
            if len(p) > self.longest:
                del self.new[p]
        return found

    def _encode_spaced(self, words: list[bytes]) -> list[bytes]:
        """Each with the space before it: only the first token of a word starts with a space."""
        ids = np.array(self.words.encode_batch_fast([_joined(words)], add_special_tokens=False)[0].ids, np.uint32)
        return _parts(ids, self.opens[ids])

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        made = self.words.encode_batch([_joined(words)], add_special_tokens=False)[0]
        of = np.array(made.word_ids)
        return _parts(np.array(made.ids, np.uint32), np.append(True, of[1:] != of[:-1]))

    def _encode_rest(self, pieces: list[bytes]) -> list[bytes]:
        made = self.library.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in made]

    def encode(self, texts: Iterable[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text (null: of an empty one)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        if not n:
            return []
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        at = cuts(data)
        for s in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                at[ends[k] : ends[k + 1]] = False
        at[ends[:-1][ends[:-1] < ends[1:]]] = True
        at = np.append(np.flatnonzero(at), len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if at.dtype == np.int32 else pa.large_binary()
        pieces = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids_of(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        of_piece = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        bounds = of_piece[np.searchsorted(at, ends)].tolist()
        raw = ids.buffers()[2].to_pybytes() if len(ids) else b""
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])]


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each file and Python worker; reused by later tasks."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]
