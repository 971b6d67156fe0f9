"""Token ids by a public tokenizer that cuts at white space, with a word cache in each Python worker.

The tokenizers this serves drop white space and cut letters from punctuation before anything else, so the ids of a text are
those of its words in order, and the ids of a word that ends in plain punctuation are those of its two parts. Each distinct
word is encoded once for as long as the cache holds it; the cache has two generations of bounded size, and a word that is
met again moves to the younger one.
"""

from __future__ import annotations

import os

import numpy as np

#: Words in one generation of a worker's cache.
CACHE_WORDS = 400_000
#: Punctuation that is cut off a word's end.
PUNCTUATION = b".,;:!?#*$%&|"

_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """`known`: word, with A-Z in lower case as the tokenizer has it (but for words that could hold a special token), to its ids as unsigned little-endian 32-bit numbers."""

    def __init__(self, path: str):
        # Spark runs a task for each core; the library's own threads would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        core = word.rstrip(PUNCTUATION)
        if core and len(core) < len(word) and b"'" not in word and b"<|" not in word and (core.isalpha() or core.decode().lower()[-1].isalpha()):
            return core, word[len(core) :]
        return None

    def learn(self, words: set[bytes]) -> None:
        """Make sure that `known` holds all of `words`."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.older, self.known, new = self.known, {}, [*words]
        known, older = self.known, self.older
        split: dict[bytes, tuple[bytes, bytes]] = {}
        whole: set[bytes] = set()
        for w in new:
            if w in older:
                known[w] = older[w]
            elif two := self.parts(w):
                split[w] = two
                for x in two:
                    if x in older:
                        known[x] = older[x]
                    elif x not in known:
                        whole.add(x)
            else:
                whole.add(w)
        todo = [*whole]
        if todo:
            for w, e in zip(todo, self.tokenizer.encode_batch_fast([w.decode() for w in todo], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w, (core, tail) in split.items():
            known[w] = known[core] + known[tail]


def encode(text: str, path: str) -> bytes:
    """The ids of `text` as unsigned little-endian 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    encoder = _encoders[path]
    raw = text.encode()
    words = raw.lower().split()
    if b"<|" in raw:  # the tokenizer finds its special tokens before it lowers anything
        words = [w if b"<|" in w else w.lower() for w in raw.split()]
    ids = [*map(encoder.known.get, words)]
    try:
        return b"".join(ids)
    except TypeError:  # a word isn't in the cache; the others aren't looked up again
        missing = [k for k, v in enumerate(ids) if v is None]
        encoder.learn({words[k] for k in missing})
        for k in missing:
            ids[k] = encoder.known[words[k]]
        return b"".join(ids)
