"""Cached encoding with a byte-level BPE of the tokenizers library.

Such a tokenizer first cuts a text into pieces, never merges across them, and a space
only ever begins a piece. So a text without two adjacent spaces falls into chunks at
its spaces, each kept with its leading space, that the library encodes on their own
just as inside the text. A worker encodes each chunk once and looks it up afterwards.
Texts with adjacent spaces or a special string go to the library whole. Files of any
other kind go through the library text by text.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks that a worker keeps; then it starts anew. Bounds memory, not results.
CACHE = 1_000_000
#: Letters below this code point have been letters in every version of Unicode in use.
LETTERS = "\u0250"
#: How byte-level vocabularies write bytes: those that print stand for themselves, the
#: others for the code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def read_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of the vocabulary file, the library and its version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.encode()).hexdigest()


class Encoder:
    """`encode(texts)` gives the ids of each text as an array of uint32."""

    def __init__(self, path: str):
        self.path, self.words, self.heads, self.parts = path, {}, {}, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole: Callable = lambda texts: model.encode(texts, num_threads=1)
            self.chunked, self.special = False, []
            self.size = model.get_piece_size()
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, plain = parts.get("pre_tokenizer") or {}, parts.get("normalizer") is None
        self.chunked = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.special = [x["content"] for x in parts.get("added_tokens", [])]
        self.whole = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.line_break = array("I", self.whole(["\n"])[0]).tobytes()
        self.merge = model.model.tokenize
        self.size = model.get_vocab_size(with_added_tokens=True)

    def _word(self, part: str) -> bytes:
        """Ids of letters, with or without the space before them: one piece, merged by the library's model."""
        found = self.parts.get(part)
        if found is None:
            mapped = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(SHOWN)
            found = self.parts[part] = array("I", [token.id for token in self.merge(mapped)]).tobytes()
        return found

    def _whole(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = array("I", self.whole([part])[0]).tobytes()
        return found

    def _chunk(self, chunk: str, lead: str) -> bytes:
        """Ids of a chunk: of its lines, and of a word and the ASCII punctuation after it, apart."""
        if chunk.isalpha() and max(chunk) < LETTERS:
            return self._word(lead + chunk)
        stem = chunk[:-1]
        if chunk[-1:] in PUNCTUATION and stem.isalpha() and max(stem) < LETTERS:
            return self._word(lead + stem) + self._whole(chunk[-1])
        lines = chunk.split("\n")
        if any(line.split() != [line] for line in lines):  # other white space, or empty
            return array("I", self.whole([lead + chunk])[0]).tobytes()
        out = []
        for line in lines:
            stem = line.rstrip(PUNCTUATION)
            tail = line[len(stem) :]
            if not tail or not stem or not (stem[-1].isalpha() and stem[-1] < LETTERS):
                stem, tail = line, ""
            letters = stem.isalpha() and max(stem) < LETTERS
            out += [self.line_break, (self._word if letters else self._whole)(lead + stem), self._whole(tail) if tail else b""]
            lead = ""
        return b"".join(out[1:])

    def _lookup(self, cache: dict, chunks: Iterable[str], lead: str) -> None:
        for chunk in chunks:
            if chunk not in cache:
                cache[chunk] = self._chunk(chunk, lead)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if not self.chunked or "  " in text or any(s in text for s in self.special):
                out.append(np.array(self.whole([text])[0], "<u4").tobytes())
                continue
            if len(self.words) > CACHE or len(self.heads) > CACHE or len(self.parts) > CACHE:
                self.words, self.heads, self.parts = {}, {}, {}
            head, *rest = text.split(" ")
            if head not in self.heads:
                self._lookup(self.heads, [head], "")
            try:
                found = b"".join(map(self.words.__getitem__, rest))
            except KeyError:
                self._lookup(self.words, rest, " ")
                found = b"".join(map(self.words.__getitem__, rest))
            out.append(self.heads[head] + found)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
