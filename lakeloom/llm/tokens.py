"""Token ids of texts by a public tokenizer, one look-up per repeated word.

A tokenizer whose pre-tokenizer breaks at blanks gives the same ids whether it sees
a text or its blank-separated parts, so each distinct part is encoded once and its
ids are kept packed. Parts are cut at 0x20 (and at 0x0A where the tokenizer drops
white space); all other text goes to the tokenizer as it is. The store of parts is
emptied when it holds `most_parts`, so memory does not grow with the input.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

_MARKS = b".,;:!?#*$%&|"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _is_plain(t: str) -> bool:
    """Letters only, lower case and composed: what lower-casing and composing leave as it is."""
    return t.isalpha() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t))


@lru_cache(maxsize=4)
def encoder(path: str, drops_blanks: bool) -> PartEncoder:
    """One encoder for all tasks of a worker process."""
    return PartEncoder(path, drops_blanks)


class PartEncoder:
    """encode(UTF-8 texts) -> their ids, packed as little-endian unsigned 32-bit numbers.

    `drops_blanks`: the tokenizer lower-cases and forgets white space, and splits letters
    from marks. Then capitals A-Z are lowered beforehand (unless the text has combining
    marks, which lowering could join to a letter, or a special token's bracket), and marks at
    the end of a part are looked up apart. Otherwise a space stays with the part it precedes.
    """

    def __init__(self, path: str, drops_blanks: bool, most_parts: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task; each more would hold memory of its own
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._drops, self._most = drops_blanks, most_parts
        self._held: dict[bytes, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(1 + max(vocabulary.values(), default=0), dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        if drops_blanks:  # the same model without normalizer, for words that it would not change
            from tokenizers import pre_tokenizers

            self._bare = Tokenizer(self._tokenizer.model)
            self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _learn(self, parts: list[bytes]) -> None:
        """Encode parts; letters-only ones many at a time, told apart by the ids that end a word."""
        texts = [p.decode() for p in parts]
        if self._drops and self._ends.any():
            pure = [(p, t) for p, t in zip(parts, texts, strict=True) if _is_plain(t)]
            runs = [pure[i : i + 256] for i in range(0, len(pure), 256)]
            coded = self._bare.encode_batch_fast([" ".join(t for _, t in run) for run in runs], add_special_tokens=False)
            for run, c in zip(runs, coded, strict=True):
                ids = np.array(c.ids, dtype="<u4")
                ends = np.flatnonzero(self._ends[ids]) + 1
                if len(ends) == len(run):  # else a letter fell apart; its run is encoded one by one below
                    packed, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self._held.update((p, packed[cuts[i] : cuts[i + 1]]) for i, (p, _) in enumerate(run))
            rest = [(p, t) for p, t in zip(parts, texts, strict=True) if p not in self._held]
            parts, texts = [p for p, _ in rest], [t for _, t in rest]
        coded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self._held.update((p, array("I", c.ids).tobytes()) for p, c in zip(parts, coded, strict=True))

    def _parts(self, raw: bytes) -> list[bytes]:
        if not self._drops:
            head, *rest = raw.split(b" ")
            return [head, *(b" " + p for p in rest)]
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return raw.replace(b"\n", b" ").split(b" ")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self._held) > self._most:
            self._held.clear()
        held = self._held
        parts = [self._parts(t) for t in texts]
        new = set().union(*parts) - held.keys()
        if new and self._drops:
            whole, cut = [], []
            for p in new:
                stem = p.rstrip(_MARKS)
                if len(stem) < len(p) and stem and stem[-1] in _ALNUM:
                    cut.append((p, stem, p[len(stem) :]))
                else:
                    whole.append(p)
            need = {x for _, a, b in cut for x in (a, b)} - held.keys()
            self._learn([*whole, *(need - set(whole))])
            held.update((p, held[a] + held[b]) for p, a, b in cut)
        elif new:
            self._learn(list(new))
        look = held.__getitem__
        return [b"".join(map(look, ps)) for ps in parts]
