"""Token ids of whole texts under the lower-casing word vocabulary, by the tokenizers library.

The library's model merges every distinct word once per worker and cache fill; the words of a batch are found with
array operations. A text with code points outside the range whose normalisation and classes are plain goes through the
library as a whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from tessera.llm.common import spans_of_bytes
from tessera.llm.pretokens import NUMBER, OTHER, SPACE, PieceCache, class_table, code_points, contractions, ids_of_pieces, mixed, per_text, runs

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Code points under this are composed already, and lower-case to one code point each but for the one in _ODD.
PLAIN = 0x250
_ODD = re.compile(f"[^\x00-{chr(PLAIN - 1)}]|İ")
BATCH_CHARS = 1_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible in Latin-1, else the next code point from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in visible else free))
        free += b not in visible
    return out


class WordTokenizer:
    def __init__(self, path: str, cache: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.kinds = class_table(PLAIN)
        self.codes = mixed(np.arange(PLAIN))
        self.lower = np.fromiter((ord(chr(c).lower()[0]) for c in range(PLAIN)), np.uint32, PLAIN)
        self.letters = byte_letters()
        self.cache = PieceCache(cache)

    def word(self, piece: str) -> list[int]:
        if not piece.isascii() or min(piece) < "!":
            piece = "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(piece)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (unsigned 32 bit), and the offsets of the texts in them."""
        ids, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for a, b in spans_of_bytes(texts, BATCH_CHARS):
            part, offsets = self._batch(texts[a:b])
            ids.append(part)
            ends.append(offsets[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, x in enumerate(texts) if not x.isascii() and _ODD.search(x)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        ids, offsets = self._plain(plain)
        if not odd:
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for i in odd:
            parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = code_points(texts)
        points = self.lower[points]
        kinds = self.kinds[points]
        start, end = runs(kinds, starts, single=NUMBER)
        kind = kinds[start] if len(start) else start
        text_end = starts[np.searchsorted(starts, start, side="right")] if len(start) else start
        take = contractions(points, kinds, start, end, text_end, kind == OTHER)
        if take.any():
            end = end + take
            start = start + np.concatenate(([0], take[:-1]))
        keep = (kind != SPACE) & (start < end)
        start, end = start[keep], end[keep]
        flat = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

        def fresh(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = [self.word(flat[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
            return np.array([t for x in lists for t in x], np.uint16), np.array([len(x) for x in lists], np.int64)

        ids, counts = ids_of_pieces(self.cache, self.codes, points, start, end, fresh)
        return ids.astype(np.uint32), per_text(counts, start, starts)


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for each Python worker."""
    return WordTokenizer(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with the end id after it."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    places = offsets[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[places] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
