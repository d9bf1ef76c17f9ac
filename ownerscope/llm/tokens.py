"""Token ids of whole texts with the tokenizers library, words remembered per worker.

The BPE vocabulary drops white space and never joins across it, so a text's ids are its words' ids in order. Most words
repeat, so each worker keeps the ids of the words it has seen (a bounded store) and hands only new ones to the library.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

END_ID = 1
PUNCTUATION = ".,;:!?*&%$#|"
REMEMBERED = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes; equal to the library's whole-text ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _learn(self, words: Iterable[str]) -> None:
        """New words; a run of punctuation after a letter or digit is a token group of its own."""
        known = self.known
        split, need = [], set()
        for w in words:
            head = w.rstrip(PUNCTUATION)
            if head and head != w and head[-1].isalnum():
                tail = w[len(head):]
                split.append((w, head, tail))
                if head not in known:
                    need.add(head)
                if tail not in known:
                    need.add(tail)
            else:
                need.add(w)
        plain, other = [], []
        for w in need:
            (plain if w.isascii() and w.isalpha() else other).append(w)
        tokenize = self.tokenizer.model.tokenize
        for w in plain:  # lower-case ASCII letters are one group, unchanged by the normaliser
            known[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
        if other:
            known.update(zip(other, self._library(other)))
        for w, head, tail in split:
            known[w] = known[head] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        out: list[bytes | None] = [None] * len(texts)
        flat: list[str] = []
        ends: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            low = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            if "<|" in low and any(s in low for s in self.specials):
                out[i] = self._library([t])[0]  # the special strings are matched before the case is folded
                continue
            flat += low.replace("\n", " ").split(" ")
            ends.append((i, len(flat)))
        ids = list(map(self.known.get, flat))
        if None in ids:
            missing = [k for k, v in enumerate(ids) if v is None]
            self._learn({flat[k] for k in missing})
            for k in missing:
                ids[k] = self.known[flat[k]]
        at = 0
        for i, end in ends:
            out[i] = b"".join(ids[at:end])
            at = end
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
